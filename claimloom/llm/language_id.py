"""Language identification of mixed-language text.

Script ranges narrow each word's candidate languages; letter n-grams score the word for each candidate;
Viterbi over the words with a switching penalty labels spans. A document's language is the one whose
spans hold the most letters.
"""

from __future__ import annotations

import bisect
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from claimloom.llm.common import slices_by_bytes, text_bytes

#: Labelled rows of each language that the model is fitted on, about; they are drawn by a hash of the id.
ROWS_PER_LANGUAGE = 1500
#: Hashed letter trigrams; share of a language's letters that makes a script one of its own.
GRAMS, SCRIPT_SHARE = 1 << 15, 0.02
#: Log-likelihood that a change of language must gain.
SWITCH_PENALTY = 12.0
#: Letters times languages that are scored at once.
SLICE_CELLS = 1 << 23

#: First code points of script ranges and their names; a range runs to the next.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFF00, "latin"), (0xFF60, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
MARK = 128
_luts: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point: 1 + the number of its script if it is a letter or a mark, else 0; of marks ``MARK`` more."""
    if not _luts:
        starts = [s for s, _ in SCRIPT_STARTS]
        lut = np.zeros(0x110000, np.uint8)
        for cp in range(0x33480):  # letters end here; the rest is private use and unassigned
            if unicodedata.category(chr(cp))[0] in "LM":
                lut[cp] = 1 + SCRIPTS.index(SCRIPT_STARTS[bisect.bisect(starts, cp) - 1][1]) + MARK * (unicodedata.category(chr(cp))[0] == "M")
        _luts.append(lut)
    return _luts[0]


def _scan(texts: list[str]):
    """Code points of lower-cased texts joined by line ends; gram of every place; words as (start, end, text number)."""
    lowered = [t.lower() for t in texts]
    cps = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _letters()[cps]
    script, letter = kind % MARK, kind > 0
    code = np.where(letter, cps, 0).astype(np.uint32)
    one = np.concatenate([np.zeros(1, np.uint32), code[:-1]])
    two = np.where(one == 0, 0, np.concatenate([np.zeros(2, np.uint32), code[:-2]]))
    gram = code * np.uint32(2654435761) ^ one * np.uint32(2246822519) ^ two * np.uint32(3266489917)
    gram = ((gram ^ (gram >> np.uint32(15))) * np.uint32(668265263)) >> np.uint32(32 - GRAMS.bit_length() + 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    before = np.concatenate([[0], np.cumsum((kind > 0) & (kind < MARK))])
    lettered = before[ends] > before[starts]  # marks alone, as in keycaps and emoji, are no word
    starts, ends = starts[lettered], ends[lettered]
    sizes = np.array([len(t) + 1 for t in lowered], np.int64)
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    return gram, script, starts, ends, owner


class Model:
    """Log-probabilities of grams for each language, and the scripts that each language uses."""

    def __init__(self, langs: list[str], logp: np.ndarray, scripts: np.ndarray):
        self.langs, self.logp, self.scripts = langs, logp, scripts  # [gram, lang], [1 + script, lang]

    def word_scores(self, texts: list[str]):
        """[word, lang] scores, -inf where the script rules the language out; text number and letters of each word."""
        gram, script, starts, ends, owner = _scan(texts)
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32), owner, starts, starts
        # a word's grams: one for each letter, and one that holds its end
        wanted = np.zeros(len(gram) + 1, bool)
        wanted[: len(script)] = script > 0
        wanted[ends] = True
        places = np.flatnonzero(wanted[: len(gram)])
        first = np.searchsorted(places, starts)
        scores = np.add.reduceat(self.logp[gram[places]], first, axis=0)
        allowed = self.scripts[script[starts]]
        allowed = allowed | ~allowed.any(1, keepdims=True)  # a script that no language uses rules nothing out
        return np.where(allowed, scores, -np.inf).astype(np.float32), owner, starts, ends


def viterbi(scores: np.ndarray, owner: np.ndarray, n: int, penalty: float) -> np.ndarray:
    """Best label of every word of n texts, all texts a step at a time; ties go to the earlier language."""
    counts = np.bincount(owner, minlength=n)
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    active = np.searchsorted(-counts[order], -np.arange(1, counts.max(initial=0) + 1), "right")
    langs = scores.shape[1]
    kind = np.uint8 if langs <= 256 else np.uint32
    back = np.zeros(scores.shape, kind)
    value = np.zeros((n, langs), np.float32)
    own = np.arange(langs, dtype=kind)
    for t, k in enumerate(active.tolist()):
        at = first[order[:k]] + t
        v = value[:k]
        best = v.argmax(1)
        leave = v[np.arange(k), best] - np.float32(penalty)
        stay = v >= leave[:, None]
        back[at] = np.where(stay, own, best[:, None].astype(kind)) if t else own
        value[:k] = (np.maximum(v, leave[:, None]) if t else v) + scores[at]
    label = np.zeros(len(scores), np.int64)
    state = value.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        k = int(active[t])
        at = first[order[:k]] + t
        label[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return label


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fits on about ``rows_per_language`` whole texts of each language, drawn by a hash of the id.

    Tasks count; the driver gets GRAMS counts for each language at most, whatever the input's size.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rates = {r.lang: rows_per_language / r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(rates)
    if not langs:
        return Model([], np.zeros((GRAMS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    rate = F.create_map(*(F.lit(x) for pair in rates.items() for x in pair))[F.col("lang")]
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate * (1 << 30))

    def count(batches):
        import pyarrow as pa

        grams = np.zeros((len(langs), GRAMS + len(SCRIPTS) + 1), np.int64)
        for batch in batches:
            names, texts = np.array([langs.index(x) for x in batch.column(1).to_pylist()], np.int64), text_bytes(batch.column(0))
            for k in range(len(langs)):
                own = [texts[i].decode() for i in np.flatnonzero(names == k)]
                for lo, hi in slices_by_bytes([len(t) for t in own], 1 << 20):
                    gram, script, _, ends, _ = _scan(own[lo:hi])
                    wanted = script > 0
                    grams[k, GRAMS:] += np.bincount(script, minlength=len(SCRIPTS) + 1)
                    wanted[ends[ends < len(gram)]] = True
                    grams[k, :GRAMS] += np.bincount(gram[wanted], minlength=GRAMS)
        k, g = np.nonzero(grams)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(g, pa.int32()), pa.array(grams[k, g])], ["k", "g", "n"])

    found = drawn.select("text", "lang").mapInArrow(count, "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), GRAMS + len(SCRIPTS) + 1))
    counts[found.k, found.g] = found.n
    grams, scripts = counts[:, :GRAMS] + 0.5, counts[:, GRAMS:].copy()
    scripts[:, 0] = 0
    shares = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    return Model(langs, np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32).copy(), (shares >= SCRIPT_SHARE).T.copy())


def _label(model: Model, texts: list[str], penalty: float):
    """(language, score, spans) of every text of a slice."""
    n, langs = len(texts), len(model.langs)
    pred, score, spans = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
    scores, owner, starts, ends = model.word_scores(texts)
    if not len(owner) or not langs:
        return pred, score, spans
    sizes = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    base = (np.cumsum(sizes) - sizes)[owner]
    starts, ends = starts - base, ends - base
    label = viterbi(scores, owner, n, penalty)
    letters = np.bincount(owner * langs + label, ends - starts, n * langs).reshape(n, -1)
    total, best = letters.sum(1), letters.argmax(1)
    for i in np.flatnonzero(total).tolist():
        pred[i], score[i] = model.langs[best[i]], letters[i, best[i]] / total[i]
    cuts = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)], strict=True):
        spans[owner[a]].append({"start": int(starts[a]), "until": int(ends[b - 1]), "lang": model.langs[label[a]]})
    return pred, score, spans


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, keep: list[str] | None = None) -> DataFrame:
    """``(id, lang_pred, score, spans)`` for every whole text; no shuffle.

    ``spans``: array of (start, until, lang) in characters of the lower-cased text. ``score``: the share of
    letters in spans of ``lang_pred``. ``und`` and 0 if the text is null or has no letters, or nothing was
    learned; ties go to the earlier language; repeated rows and null ids come out row by row. ``keep`` names
    columns to carry along, in a struct ``row`` (whatever they are called); the others are not read. Texts are
    taken in slices of about ``SLICE_CELLS`` letters times languages, those of similar length together; a
    longer text is a slice of its own.
    """
    limit = max(1 << 16, SLICE_CELLS // max(len(model.langs), 1))
    held = keep is not None and text_col in keep

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            column = batch.column("row").field(keep.index(text_col)) if held else batch.column("text")
            texts = text_bytes(column)
            sizes = np.array([len(x) for x in texts], np.int64)
            order = np.argsort(sizes, kind="stable")
            pred, score, spans = ["und"] * len(texts), np.zeros(len(texts)), [[]] * len(texts)
            for lo, hi in slices_by_bytes(sizes[order].tolist(), limit):
                own = order[lo:hi].tolist()
                for i, p, x, s in zip(own, *_label(model, [texts[i].decode() for i in own], penalty), strict=True):
                    pred[i], score[i], spans[i] = p, x, s
            carried = [batch.column("row")] if keep is not None else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind), *carried], ["id", "lang_pred", "score", "spans", *(["row"] if carried else [])])

    row = [] if keep is None else [F.struct(*keep).alias("row")]
    text = [] if held else [F.col(text_col).alias("text")]
    chosen = docs.select(F.col(id_col).alias("id"), *text, *row)
    span = StructType([StructField("start", LongType()), StructField("until", LongType()), StructField("lang", StringType())])
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(span))]
    out = chosen.mapInArrow(run, StructType([StructField("id", docs.schema[id_col].dataType), *made, *chosen.schema.fields[len(chosen.columns) - len(row) :]]))
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
