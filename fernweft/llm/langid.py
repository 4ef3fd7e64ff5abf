"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter's maximum over the window is pooled, and a softmax layer gives the
language. Training is plain numpy with Adam; the maximum passes a gradient to
one position for each filter, so the backward pass is sparse. A text is cut
into windows without gaps, all of which are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]")
#: Windows scored at once, which bounds the memory of a forward pass.
LOT = 512
#: First and last letters of scripts that made-up texts are drawn from; those
#: after the first stand for languages that no label names.
SCRIPTS = (
    (0x61, 0x7A), (0x3B1, 0x3C9), (0x430, 0x44F), (0x561, 0x586), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0x985, 0x9A8), (0xB85, 0xBB9),
    (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x1200, 0x1248), (0x1780, 0x17A2), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)


@dataclass(frozen=True)
class Training:
    """Bounds and settings of a fit.

    Every labelled language is learned. About ``rows_per_language`` of its texts
    at most are drawn for each, and fewer where that is more than ``rows`` in
    all, but ``least_rows``; and ``windows`` windows of ``window`` bytes from
    each, as long as the net's.
    ``strangers``: made-up texts, as a share of those windows, that the net
    learns as ``und``; without them it knows only the labelled languages.
    """

    rows_per_language: int = 1500
    rows: int = 60_000
    least_rows: int = 16
    windows: int = 3
    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    embedding: int = 6
    epochs: int = 8
    lot: int = 64
    rate: float = 0.01
    seed: int = 7
    strangers: float = 0.0


@dataclass
class ByteNet:
    """Parameters; ``kernel`` holds all filters at the greatest width, with
    zeros where a filter is narrower."""

    languages: list[str]
    window: int
    table: np.ndarray
    kernel: np.ndarray
    mask: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def initial(cls, languages: list[str], t: Training) -> ByteNet:
        rng = np.random.default_rng(t.seed)
        wide, n = max(t.widths), t.filters * len(t.widths)
        mask = np.zeros((wide, t.embedding, n), np.float32)
        for k, w in enumerate(t.widths):
            mask[:w, :, k * t.filters : (k + 1) * t.filters] = 1
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        return cls(
            languages, t.window, normal(256, t.embedding) * 0.5, normal(*mask.shape) * 0.3 * mask, mask,
            np.zeros(n, np.float32), normal(n, len(languages)) * 0.2, np.zeros(len(languages), np.float32),
        )

    def convolve(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter values at every place of uint8 windows, and the patches."""
        wide, depth, n = self.kernel.shape
        emb = self.table[windows].reshape(len(windows), -1)
        places = windows.shape[1] - wide + 1
        patches = np.lib.stride_tricks.sliding_window_view(emb, wide * depth, axis=1)[:, ::depth]
        flat = np.ascontiguousarray(patches).reshape(len(windows) * places, wide * depth)
        return (flat @ self.kernel.reshape(-1, n)).reshape(len(windows), places, n), flat

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        values, _ = self.convolve(windows)
        return softmax(np.maximum(values.max(axis=1) + self.bias, 0) @ self.out + self.out_bias)

    def fit(self, windows: np.ndarray, labels: np.ndarray, t: Training) -> None:
        """Minimise cross-entropy over lots in shuffled order."""
        rng = np.random.default_rng(t.seed + 1)
        names = ("table", "kernel", "bias", "out", "out_bias")
        moments = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in names}
        step, total = 0, t.epochs * -(-len(windows) // t.lot)
        for _ in range(t.epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), t.lot):
                lot = order[at : at + t.lot]
                step += 1
                rate = t.rate * (1 - 0.9 * step / total)
                for name, g in self.gradients(windows[lot], labels[lot]).items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    scaled = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, getattr(self, name) - rate * scaled)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        wide, depth, n = self.kernel.shape
        values, flat = self.convolve(windows)
        rows, places, _ = values.shape
        best = values.argmax(axis=1)
        pooled = np.take_along_axis(values, best[:, None, :], axis=1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        error = softmax(hidden @ self.out + self.out_bias)
        error[np.arange(rows), labels] -= 1
        error /= rows
        back = (error @ self.out.T) * (pooled > 0)
        at = (np.arange(rows)[:, None] * places + best).ravel()
        patches = flat[at].reshape(rows, n, wide, depth)
        kernel = np.einsum("rn,rnwd->wdn", back, patches) * self.mask
        spread = (back[:, :, None, None] * self.kernel.transpose(2, 0, 1)[None]).reshape(-1, depth)
        index = best[:, :, None] + np.arange(wide)
        table = np.zeros_like(self.table)
        np.add.at(table, windows[np.arange(rows)[:, None, None], index].ravel(), spread)
        return {"table": table, "kernel": kernel, "bias": back.sum(0), "out": hidden.T @ error, "out_bias": error.sum(0)}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the mean over its windows of the
        probability, weighted by their bytes. Texts without letters, null or
        empty ones included, are ``und`` with score 0; so are all where the
        net knows no language."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        judged, sums, sizes = self.weighed(texts)
        for i in judged:
            k = int(sums[i].argmax())
            names[i], scores[i] = self.languages[k], float(min(1.0, sums[i, k] / sizes[i]))
        return names, scores

    def weighed(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Texts with letters, and sums of their windows' probabilities and bytes."""
        sums = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts))
        judged = [i for i, t in enumerate(texts) if has_letters(t)]
        for owners, windows, weights in lots(((i, texts[i]) for i in judged), self.window):
            np.add.at(sums, owners, self.probabilities(windows) * weights[:, None])
            np.add.at(sizes, owners, weights)
        return judged, sums, sizes

    def known(self, texts: list[str | None]) -> list[tuple[float, float, str]]:
        """Probability that each text is of any known language, the share of
        the likeliest in it, and its name; (-1, 0, und) without letters, and
        (1, 1, und) with letters if the net knows no language."""
        if set(self.languages) <= {UNKNOWN}:
            return [(1.0, 1.0, UNKNOWN) if has_letters(t) else (-1.0, 0.0, UNKNOWN) for t in texts]
        judged, sums, sizes = self.weighed(texts)
        out, known = [(-1.0, 0.0, UNKNOWN)] * len(texts), [k for k, name in enumerate(self.languages) if name != UNKNOWN]
        for i in judged:
            k, total = max(known, key=lambda k: sums[i, k]), sums[i, known].sum()
            out[i] = (float(min(1.0, total / sizes[i])), float(sums[i, k] / total), self.languages[k])
        return out


def has_letters(text: str | None) -> bool:
    """Digits such as superscripts are word characters, but no letters."""
    return any(m.group().isalpha() for m in _letter.finditer(text or ""))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(text: str | bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's bytes, A-Z lower-cased, as windows filled up with zeros, and
    the number of bytes in each."""
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "replace")
    raw = np.frombuffer(raw.lower(), np.uint8)
    n = -(-len(raw) // window)
    full = np.zeros(n * window, np.uint8)
    full[: len(raw)] = raw
    weights = np.full(n, window, np.float64)
    if n:
        weights[-1] = len(raw) - (n - 1) * window
    return full.reshape(n, window), weights


def lots(texts: Iterator[tuple[int, str]], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of all texts in lots of ``LOT``, with the text each is from."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0
    for i, text in texts:
        windows, weights = cut(text, window)
        for at in range(0, len(windows), LOT):
            part = windows[at : at + LOT]
            held.append((np.full(len(part), i), part, weights[at : at + LOT]))
            count += len(part)
            if count >= LOT:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def sample(labelled: DataFrame, t: Training, text_col: str, lang_col: str) -> list[tuple[str, list[bytes]]]:
    """Up to a bounded number of texts of each language, as windows of bytes.

    Rows with null language or text are left out. The draw is by a hash of the
    text, so equal texts and languages with most rows do not crowd out others,
    and only the windows leave the executors."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # The net has an output for each language, so the driver may hold a number
    # for each; a join would shuffle texts by language.
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return []
    each = min(t.rows_per_language, max(t.least_rows, t.rows // len(counts)))
    limits = [x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, each / n) * float(1 << 30)))]
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.coalesce(F.create_map(*limits)[F.col("lang")], F.lit(-1.0))
    raw = F.encode("text", "utf-8")
    size = F.greatest(F.lit(1), F.octet_length(raw) - t.window)
    starts = [F.pmod(F.xxhash64("text", F.lit(k)), size.cast("long")).cast("int") + 1 for k in range(t.windows)]
    windows = F.array(*[F.substring(raw, s, F.lit(t.window)) for s in starts])
    picked = rows.where(drawn).select("lang", windows.alias("windows"), F.xxhash64("text").alias("key"))
    picked = picked.dropDuplicates(["lang", "key"])
    return sorted((r["lang"], [bytes(w) for w in r["windows"]]) for r in picked.toLocalIterator())


def made_up(n: int, learned: list[str], t: Training) -> list[str]:
    """Texts of no language, as long as learned ones: letters at random, half
    of them Latin, and half of other scripts that no learned text uses."""
    rng = np.random.default_rng(t.seed + 2)
    used = {c for text in learned for c in set(text.lower())}
    foreign = [s for s in SCRIPTS[1:] if not any(s[0] <= ord(c) <= s[1] for c in used)]
    out = []
    for i in range(n):
        first, last = foreign[rng.integers(len(foreign))] if foreign and i % 2 else SCRIPTS[0]
        # Few letters or all, even or uneven, in words or run together.
        letters = rng.permutation(np.arange(first, last + 1))[: rng.integers(8, last - first + 2)]
        if i % 4 == 2:
            letters = np.concatenate([letters, np.arange(0x30, 0x3A)])
        odds = rng.dirichlet(np.full(len(letters), rng.choice([0.5, 3.0, 100.0])))
        size = len(learned[rng.integers(len(learned))])
        chars = [chr(c) for c in rng.choice(letters, size=size, p=odds)]
        gap = rng.choice([0.08, 0.15, 0.25]) if rng.random() < 0.75 else 0.0
        out.append("".join(" " if k and blank else c for k, (c, blank) in enumerate(zip(chars, rng.random(len(chars)) < gap))))
    return out


def train(labelled: DataFrame, t: Training = Training(), text_col: str = "text", lang_col: str = "lang") -> ByteNet:
    """Fit a net on labelled rows, within the bounds of ``t``.

    Without usable rows the net knows no language and answers ``und``.
    """
    drawn = sample(labelled, t, text_col, lang_col)
    # A window may start or end within a character, as all windows may.
    texts = [(lang, w) for lang, ws in drawn for w in ws if has_letters(w.decode("utf-8", "ignore"))]
    if texts and t.strangers:
        learned = [w.decode("utf-8", "ignore") for _, w in texts]
        texts += [(UNKNOWN, w.encode()) for w in made_up(int(len(texts) * t.strangers), learned, t) if has_letters(w)]
    languages = sorted({lang for lang, _ in drawn} | {lang for lang, _ in texts})
    net = ByteNet.initial(languages, t)
    pairs = [(cut(w, t.window)[0][0], languages.index(lang)) for lang, w in texts]
    if pairs:
        net.fit(np.stack([w for w, _ in pairs]), np.array([k for _, k in pairs]), t)
    return net


def language_column(net: ByteNet, text: Column) -> Column:
    """Struct of ``lang`` and ``score`` for each text; never null."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = net.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predicted(text)


def identify(docs: DataFrame, net: ByteNet, name: str = "language", text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``name`` of predicted ``lang`` and ``score``.

    Only texts are read by the prediction. Null texts and texts without
    letters are ``und`` with score 0; long texts are scored whole. Rows are
    judged one by one: ties and repeated rows need no rule. A column named
    ``name`` is replaced. An empty table gives no rows.
    """
    return docs.withColumn(name, language_column(net, F.col(text_col)))


def reject_unknown(docs: DataFrame, net: ByteNet, least_known: float = 0.0, least_share: float = 0.0, languages: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """Rows of known languages with probability ``least_known`` or more, the
    likeliest of which has ``least_share`` of that and is among ``languages``
    (None: any that the net knows), with all columns of the input.

    Null texts and texts without letters go; a net without languages rejects
    only those. Long texts are scored whole. Rows are judged one by one, so
    repeated rows stay or go together. An empty table gives no rows."""

    @F.arrow_udf("boolean")
    def stays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = net.known(texts.to_pylist())
            fits = [p >= max(0.0, least_known) and s >= least_share and (languages is None or name in (*languages, UNKNOWN)) for p, s, name in found]
            yield pa.array(fits, pa.bool_())

    return docs.where(stays(F.col(text_col)))
