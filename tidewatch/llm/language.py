"""Language identification in two steps: family first, then one-versus-one within it.

All machines are linear support vector machines over hashed byte n-grams. They are
fitted on a bounded sample (``max_rows`` labelled documents a language, the least by
hash of the id), each machine in a task of its own. Every whole text is then scored
where it lies. Only the text is ever an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import checked_broadcast, fresh, materialize

# Families of two-letter language codes. Others are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr pa gu ne ur",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
SIZE = 1 << 12
_LETTER = regex.compile(r"\p{L}")
#: ASCII but letters becomes a space; texts are lower-cased before.
_TABLE = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint32)


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower(), lang)


def features(text: str | None) -> np.ndarray:
    """Square roots of hashed 1-, 2- and 3-gram counts of bytes, of unit length."""
    b = _TABLE[np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "surrogatepass"), np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(8191) + b[2:]
    spread = lambda x: (x * np.uint32(2654435761)) >> np.uint32(32 - 12)
    count = np.bincount(spread(three), minlength=SIZE) + np.bincount(spread(two + np.uint32(1 << 20)), minlength=SIZE) + np.bincount(spread(b + np.uint32(1 << 24)), minlength=SIZE)
    root = np.sqrt(count).astype(np.float32)
    return root / max(float(np.linalg.norm(root)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 200) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss; y is +1 or -1.

    Classes weigh alike. Accelerated gradient descent from zero, so the same rows in
    the same order give the same machine.
    """
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1 / (1 / cost + 2 * 2))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = v / np.float32(cost) - 2 * (x.T @ (weight * slack * y))
        new = v - rate * grad
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def machines(langs: list[str]) -> list[tuple[str, str, str, list[str], list[str]]]:
    """(kind, a, b, languages for +1, for -1): families against the rest, pairs within families."""
    families: dict[str, list[str]] = {}
    for lang in sorted(langs):
        families.setdefault(family_of(lang), []).append(lang)
    out = []
    if len(families) > 1:
        names = sorted(families)
        for name in names if len(names) > 2 else names[:1]:
            out.append(("family", name, "" if len(names) > 2 else names[1], families[name], [x for x in langs if family_of(x) != name]))
    for members in families.values():
        out += [("pair", a, b, [a], [b]) for i, a in enumerate(members) for b in members[i + 1 :]]
    return out


def train(docs: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 1000) -> dict:
    """Fit all machines on at most ``max_rows`` rows a language of those ``usable``.

    The sample are the rows with the least hashes of id and text; a machine of many
    languages takes fewer rows of each. The driver gets the list of languages and one
    weight vector for each machine.

    Defined cases: rows with a null id, language or text are not used, nor are texts
    without a letter; repeated rows count once; a language with fewer rows gives those it
    has; no usable rows, or one language, give a model without machines.
    """
    key = F.xxhash64(F.col(doc_id), F.col(text))
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(key.alias("key"), F.col(lang).alias("lang"), F.col(text).alias("body"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    # Hashes are uniform, so the least of a language lie under a bound: a window sees about 4 * max_rows rows, not all.
    bound = F.least(F.lit(1.0), F.lit(4.0 * max_rows) / F.col("n"))
    low = rows.select("key", "lang").join(F.broadcast(counts), "lang").where((F.col("key") / 2.0**64 + 0.5) <= bound).select("key", "lang").distinct()
    order = Window.partitionBy("lang").orderBy("key")
    ids = materialize(low.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_rows), "language-sample")
    sample = rows.join(checked_broadcast(ids, 1 << 18), ["key", "lang"]).dropDuplicates(["key", "lang"])

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keep = pdf[np.array([bool(_LETTER.search(t)) for t in pdf["body"]], bool)]
            yield pd.DataFrame({"key": keep["key"], "k": keep["k"], "lang": keep["lang"], "x": pd.Series([features(t) for t in keep["body"]], index=keep.index, dtype=object)})

    langs = sorted(r.lang for r in ids.select("lang").distinct().collect())
    plan = machines(langs)
    if not plan:
        return {"langs": langs, "plan": [], "weights": np.zeros((0, SIZE + 1), np.float32)}
    side = docs.sparkSession.createDataFrame([(i, x, sign, -(-max_rows // len(group))) for i, (_, _, _, plus, minus) in enumerate(plan) for sign, group in ((1, plus), (-1, minus)) for x in group], "machine int, lang string, y int, most int")

    def fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "lang"])
        w = fit_svm(np.stack(pdf["x"].tolist()).astype(np.float32), pdf["y"].to_numpy(np.float32))
        return pd.DataFrame({"machine": [int(pdf["machine"].iloc[0])], "w": [w.tolist()]})

    table = sample.mapInPandas(measured, "key long, k int, lang string, x array<float>").join(F.broadcast(side), "lang").where("k <= most")  # a side of a machine has about max_rows rows
    weights = np.zeros((len(plan), SIZE + 1), np.float32)
    for row in table.select("machine", "key", "lang", "y", "x").groupBy("machine").applyInPandas(fit_one, "machine int, w array<float>").collect():
        weights[row.machine] = row.w
    return {"langs": langs, "plan": [p[:3] for p in plan], "weights": weights}


def decide(model: dict, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of machine margins."""
    n, sure = len(margins), lambda m: 1 / (1 + np.exp(-2 * m))
    by_family: dict[str, list[str]] = {}
    for lang in model["langs"]:
        by_family.setdefault(family_of(lang), []).append(lang)
    names = sorted(by_family)
    at = {p: i for i, p in enumerate(model["plan"])}
    if len(names) == 2:
        m = margins[:, at["family", names[0], names[1]]]
        family_margin = np.stack((m, -m), axis=1)
    elif len(names) > 2:
        family_margin = np.stack([margins[:, at["family", f, ""]] for f in names], axis=1)
    else:
        family_margin = np.full((n, 1), 20.0)
    chosen = family_margin.argmax(axis=1)
    score = sure(family_margin.max(axis=1))
    out = np.empty(n, object)
    for f, name in enumerate(names):
        rows, members = np.flatnonzero(chosen == f), by_family[name]
        votes, worst = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), 20.0)
        for i, a in enumerate(members):
            for j in range(i + 1, len(members)):
                m = margins[rows, at["pair", a, members[j]]]
                votes[:, i] += (m >= 0) + 1e-6 * np.tanh(m)
                votes[:, j] += (m < 0) - 1e-6 * np.tanh(m)
                worst[:, i], worst[:, j] = np.minimum(worst[:, i], m), np.minimum(worst[:, j], -m)
        best = votes.argmax(axis=1)
        out[rows] = [members[b] for b in best]
        score[rows] *= sure(worst[np.arange(len(rows)), best])
    return out.tolist(), score


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (columns of these names are replaced).

    Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is
    every text if no language was learned; a single learned language is always the
    answer; a tie goes to the language that comes first; texts of any length are judged
    whole; repeated rows are judged alike; an empty table stays empty.
    """
    @F.pandas_udf("lang_pred string, lang_score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model["langs"] else []
        texts = texts.tolist()
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            x = np.stack([features(texts[i]) for i in part])
            margins = x @ model["weights"][:, :-1].T + model["weights"][:, -1]
            pred[part], score[part] = decide(model, margins)
        return pd.DataFrame({"lang_pred": pred, "lang_score": score})

    held = fresh("language", docs)
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    return docs.withColumn(held, run(F.col(text))).select(*rest, f"{held}.lang_pred", f"{held}.lang_score")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: CRC-32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
