"""Language identification by hierarchical discrimination.

Texts become relative frequencies of hashed byte trigrams (ASCII letters lower-cased, everything else in ASCII a space). A
first set of linear support vector machines, one per family, picks the language family; within it one machine per pair of
languages votes, ties going to the larger sum of margins. All machines are L2-loss SVMs trained on the driver from a sample of
labelled rows, bounded by `max_rows` or `least` texts of each language; every language is learned. Prediction reads whole texts, streams
them through numpy in pieces and needs no shuffle.

Defined results: a null text or one without a letter is `und` with score 0; rows without a lang or a letter are not learned from; with no labelled row
every text is `und`; with one language every text with a letter is that language. Equal texts get equal predictions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.textops import column_bytes, pieces, streamed

#: Families of languages; a language that is not named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ne", "ur", "pa"),
    "sinitic": ("zh", "yue"),
}
UNDETERMINED = "und"
BUCKETS = 1 << 13
_LETTER = re.compile(r"[^\W\d_]")
_CLASS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), lang)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts one after the other, and where each text's begin (one more entry: the end)."""
    joined = b"\0".join([*(b" " + t.translate(_CLASS) + b" " for t in texts), b""])
    raw = np.frombuffer(joined, np.uint8)
    gap = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    raw = raw[keep].astype(np.uint32)
    stop = np.flatnonzero(raw == 0)
    padded = np.concatenate((raw, np.zeros(2, np.uint32)))
    code = padded[:-2] * np.uint32(0x1F3D5B79) + padded[1:-1] * np.uint32(0x9E3779B1) + padded[2:] * np.uint32(0x85EBCA6B)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code >>= np.uint32(19)
    inside = (padded[:-2] != 0) & (padded[1:-1] != 0) & (padded[2:] != 0)
    before = np.concatenate(([0], np.cumsum(inside)))
    return code[inside].astype(np.int32), np.concatenate(([0], before[stop + 1] if len(stop) else []))[: len(texts) + 1].astype(np.int64)


@dataclass
class Machines:
    """weights: BUCKETS x machines; families: name -> (column or None, languages); pairs: (a, b) -> column, positive for a."""

    weights: np.ndarray
    bias: np.ndarray
    families: dict[str, tuple[int | None, list[str]]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], int] = field(default_factory=dict)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        code, first = trigrams(texts)
        n = np.diff(first)
        out = np.zeros((len(texts), self.weights.shape[1]))
        full = np.flatnonzero(n > 0)
        if len(full) and self.weights.shape[1]:
            for m in range(self.weights.shape[1]):
                out[full, m] = np.add.reduceat(self.weights[:, m][code], first[:-1][full], dtype=np.float64) / n[full]
        return out + self.bias

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, str]]:
        """(language, score, family) of texts that have a letter."""
        return [x[:3] for x in self.judge(texts)]

    def judge(self, texts: list[bytes]) -> list[tuple[str, float, str, float]]:
        """The same, and the evidence: how much surer the machines that decided are, family and worst pair together, than if each had tossed."""
        margin = self.margins(texts)
        sure = 1 / (1 + np.exp(-3 * np.clip(margin, -20, 20)))
        names = list(self.families)
        if not names:
            return [(UNDETERMINED, 0.0, UNDETERMINED, 0.0)] * len(texts)
        columns = [self.families[f][0] for f in names]
        if len(names) == 1:
            pick, trust = np.zeros(len(texts), int), np.ones(len(texts))
            own = trust
        elif len(names) == 2:
            pick = (margin[:, columns[0]] < 0).astype(int)
            trust = np.where(pick == 0, sure[:, columns[0]], 1 - sure[:, columns[0]])
            own = 2 * trust
        else:
            pick = np.argmax(margin[:, columns], axis=1)
            all_sure = sure[:, columns]
            own = 2 * all_sure[np.arange(len(texts)), pick]
            trust = own / 2 / np.maximum(all_sure.sum(axis=1), 1e-12)
        return [self._within(names[f], margin[i], sure[i], float(trust[i]), float(own[i])) for i, f in enumerate(pick)]

    def _within(self, family: str, margin: np.ndarray, sure: np.ndarray, trust: float, own: float) -> tuple[str, float, str, float]:
        langs = self.families[family][1]
        votes = {x: [0, 0.0] for x in langs}
        for a, b in combinations(langs, 2):
            m = margin[self.pairs[a, b]]
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = max(langs, key=lambda x: (*votes[x], x))
        worst = min((sure[k] if a == best else 1 - sure[k] for (a, b), k in self.pairs.items() if best in (a, b)), default=1.0)
        return best, round(trust * float(worst), 6), family, own * float(worst) * (2 if len(langs) > 1 else 1)


def svm(gram: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 400) -> np.ndarray:
    """Dual variables times labels of an L2-loss SVM (bias inside the kernel), by projected accelerated gradients."""
    q = (gram + 1) * np.outer(y, y) + np.eye(len(y)) / (2 * c)
    v = np.ones(len(y))
    for _ in range(30):
        v = q @ v
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * float(v @ q @ v))
    alpha = look = np.zeros(len(y))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, look - step * (q @ look - 1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t2 * (new - alpha)
        alpha, t = new, t2
    return alpha * y


def train(langs: list[str], rows: list[tuple[np.ndarray, np.ndarray]]) -> Machines:
    """From each row's language and its (buckets, relative frequencies)."""
    names = sorted(set(langs))
    x = np.zeros((len(rows), BUCKETS))
    for i, (at, value) in enumerate(rows):
        x[i, at] = value
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
    x *= scale
    spread = np.sqrt((x**2).sum(axis=1).mean()) if len(rows) else 1.0
    x, scale = x / max(spread, 1e-12), scale / max(spread, 1e-12)
    gram, label = x @ x.T, np.array(langs)
    columns, bias = [], []

    def machine(of: np.ndarray, y: np.ndarray) -> int:
        beta = svm(gram[np.ix_(of, of)], y)
        columns.append((beta @ x[of]) * scale)
        bias.append(beta.sum())
        return len(columns) - 1

    kin: dict[str, list[str]] = {}
    for name in names:
        kin.setdefault(family_of(name), []).append(name)
    out = Machines(np.zeros((BUCKETS, 0)), np.zeros(0))
    everyone = np.arange(len(rows))
    for k, (f, members) in enumerate(sorted(kin.items())):
        column = None
        if len(kin) > 2 or (len(kin) == 2 and k == 0):
            column = machine(everyone, np.where(np.isin(label, members), 1.0, -1.0))
        out.families[f] = (column, members)
        for a, b in combinations(members, 2):
            of = np.flatnonzero((label == a) | (label == b))
            out.pairs[a, b] = machine(of, np.where(label[of] == a, 1.0, -1.0))
    out.weights = np.array(columns).T.astype(np.float32) if columns else out.weights
    out.bias = np.array(bias)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column_bytes(batch.column(1))
        for lo, hi in pieces(texts):
            code, first = trigrams(texts[lo:hi])
            at, value = [], []
            for i in range(hi - lo):
                found, n = np.unique(code[first[i] : first[i + 1]], return_counts=True)
                at.append(found.astype(np.int32))
                value.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["lang", "at", "value"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = 1024, least: int = 8) -> Machines:
    """Machines from the distinct texts with the smallest hashes of each language: max_rows over the number of languages, `least` if that is more, or all if it has fewer."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).collect()
    if not counts:
        return Machines(np.zeros((BUCKETS, 0)), np.zeros(0))
    each = max(least, max_rows // len(counts))
    # so many are drawn that each language has `each` among them, for the counts are near; then the smallest are kept
    shares = labelled.sparkSession.createDataFrame([(r["lang"], (2 * each + 32) / max(1, r["texts"])) for r in counts], "lang string, share double")
    draw = F.pmod("h", F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    drawn = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).groupBy("lang", "h").agg(F.first("text").alias("text"))  # of equal texts one
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(draw, "h"))).where(F.col("place") <= each)
    found = drawn.select("lang", "text").mapInArrow(streamed(_features), "lang string, at array<int>, value array<float>").toArrow()
    langs = found.column("lang").to_pylist()
    parts = [(np.array(a, np.int32), np.array(v, np.float64)) for a, v in zip(found.column("at").to_pylist(), found.column("value").to_pylist(), strict=True)]
    order = sorted(range(len(langs)), key=lambda i: (langs[i], parts[i][0].tolist(), parts[i][1].tolist()))
    return train([langs[i] for i in order], [parts[i] for i in order])


def predict(docs: DataFrame, machines: Machines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, family of every row."""
    held = docs.sparkSession.sparkContext.broadcast(machines)  # BUCKETS x machines floats, a machine per family and pair in it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_judged(held.value, batch.column(1))[:3]], ["doc_id", "lang_pred", "score", "family"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(streamed(run), "doc_id long, lang_pred string, score double, family string")


def _judged(machines: Machines, column: pa.Array) -> list[pa.Array]:
    """lang_pred, score, family and evidence."""
    texts, out = column_bytes(column), []
    for lo, hi in pieces(texts):
        lettered = [bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts[lo:hi]]
        found = iter(machines.judge([t for t, x in zip(texts[lo:hi], lettered, strict=True) if x]))
        out += [next(found) if x else (UNDETERMINED, 0.0, UNDETERMINED, 0.0) for x in lettered]
    return [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string(), pa.float64()))]


def keep_identified(docs: DataFrame, machines: Machines, text_col: str = "text", above: float = 1.2) -> DataFrame:
    """All columns of the rows whose language is determined with an evidence of at least `above` (1 is a toss; runs of consonants, base64 or
    an unlearned script get about 1.1).

    Without machines (no labelled row) or with one language, nothing can be told apart, and rows with a letter stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(machines)
    learned = sum(len(x) for _, x in machines.families.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            if learned < 2:
                yield batch.filter(pa.array([bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in column_bytes(texts)], pa.bool_()))
                continue
            lang, _, _, evidence = (x.to_pylist() for x in _judged(held.value, texts))
            yield batch.filter(pa.array([a != UNDETERMINED and e >= above for a, e in zip(lang, evidence, strict=True)], pa.bool_()))

    return docs.mapInArrow(streamed(run), docs.schema)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
