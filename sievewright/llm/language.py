"""Language identification of mixed-language texts.

Script ranges narrow the candidates of each word to the languages that are
written in its script; a per-word score (the log-likelihood of the word's padded
character trigrams) rates them, and a Viterbi pass with a penalty for switching
labels every word, which gives spans of one language each.

Learning takes whole texts of at most about ``per_language`` documents of each
language (a hash of the id decides, so it is the same documents every time). The
model holds every language and every trigram of these documents: it grows with the
number of languages and not with the corpus.

Labelling is one narrow pass: documents are never shuffled. Texts are walked
together, word by word, so a step of the Viterbi pass is one vector operation.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
no spans; null languages are not learned from; null ids are carried; a script
that no language was learned for leaves a word unrated: its letters support no
label, and a text of such words only goes to the first language in order with score
0; without any learned language all texts are ``und``; very long texts are walked whole; repeated rows are labelled each; ties go to the first language in
alphabetical order; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

#: Unicode script ranges (fixed values): first code point, name; a range ends where the next starts.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "han"), (0x30000, "other"),
)
_STARTS = [a for a, _ in SCRIPTS]
_RUN = re.compile(r"[^\W\d_]+")


def script_of(char: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(char)) - 1][1]


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, one for each run of the text that has a letter."""
    if not text:
        return []
    low = text.lower()
    # Lower-casing may lengthen a character, and so cut a run; then each run is lower-cased by itself.
    found = _RUN.findall(low) if len(low) == len(text) else [w.lower() for w in _RUN.findall(text)]
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found if (x := "".join(filter(str.isalpha, w)))]


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(word))]


def _count(batches):
    counts: Counter = Counter()
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            lang = lang.as_py()
            for word, n in Counter(letter_words(text.as_py())).items():
                counts[lang, "#" + script_of(word[0])] += n
                for gram in _grams(word):
                    counts[lang, gram] += n
        if len(counts) > 500_000:
            yield _counted(counts)
            counts = Counter()
    yield _counted(counts)


def _counted(counts):
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
        names=["lang", "gram", "n"],
    )


class LanguageModel:
    """Learned trigram log-probabilities; plain arrays, so it is cheap to send."""

    def __init__(self, rows: list[tuple[str, str, int]], smoothing: float = 0.5):
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        grams = sorted({r[1] for r in rows if r[1][0] != "#"})
        self.index = {g: i for i, g in enumerate(grams)}
        counts = np.zeros((len(grams) + 1, len(self.langs)))
        scripts: dict[str, np.ndarray] = {}
        for lang, gram, n in rows:
            if gram[0] == "#":
                scripts.setdefault(gram[1:], np.zeros(len(self.langs)))[at[lang]] += n
            else:
                counts[self.index[gram], at[lang]] += n
        total = counts.sum(0)
        self.scores = np.log((counts + smoothing) / (total + smoothing * (len(grams) + 1)))
        self.scores[-1] = self.scores[-1].mean() if len(self.langs) else 0  # an unknown trigram favours none
        # A language is a candidate for a script if a hundredth of its words have that script.
        words = sum(scripts.values()) if scripts else np.zeros(0)
        self.candidates = {s: n * 100 >= words for s, n in scripts.items()}
        self.candidates = {s: c for s, c in self.candidates.items() if c.any()}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; languages of other scripts are ruled out."""
        k, unknown, get = len(self.langs), len(self.index), self.index.get
        grams = [[get(g, unknown) for g in _grams(w)] for w in words]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        flat = np.fromiter(chain.from_iterable(grams), np.int64, int(sizes.sum()))
        out = np.add.reduceat(self.scores[flat], np.cumsum(sizes) - sizes, axis=0) if len(flat) else np.zeros((0, k))
        for i, w in enumerate(words):
            c = self.candidates.get(script_of(w[0]))
            if c is None:
                out[i] = 0
            elif not c.all():
                out[i][~c] = -1e6
        return out


def viterbi(scores: np.ndarray, lengths: list[int], penalty: float) -> np.ndarray:
    """The best label of every row. ``scores`` holds the texts' rows one text after
    another. Between neighbours of one text a change of label costs ``penalty``."""
    n, k = scores.shape
    labels = np.zeros(n, np.int32)
    lengths_a = np.asarray(lengths)
    starts_all = np.cumsum(lengths_a) - lengths_a
    order = np.argsort(-lengths_a, kind="stable")
    order = order[lengths_a[order] > 0]
    if not len(order):
        return labels
    starts, size = starts_all[order], lengths_a[order]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with more than t words
    stay = np.zeros((n, k), bool)
    jump = np.zeros(n, np.int32)
    best = scores[starts].copy()
    for t in range(1, size[0]):
        m = active[t]
        rows = starts[:m] + t
        b = best[:m]
        top = b.argmax(1)
        from_top = b[np.arange(m), top][:, None] - penalty
        keep = b >= from_top
        stay[rows], jump[rows] = keep, top
        best[:m] = np.where(keep, b, from_top) + scores[rows]
    now = best.argmax(1).astype(np.int32)
    for t in range(size[0] - 1, -1, -1):
        m = active[t]
        rows = starts[:m] + t
        labels[rows] = now[:m]
        if t:
            held = stay[rows, now[:m]]
            now[:m] = np.where(held, now[:m], jump[rows])
    return labels


def fit_languages(documents: DataFrame, *, per_language: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows of ``documents`` (the caller leaves out held-out ones)."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return LanguageModel([])
    shares = [x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(int(1_000_000 * min(1.0, per_language / n))))]
    share = F.element_at(F.create_map(*shares), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).where("text IS NOT NULL")
    counted = sample.select("text", "lang").mapInArrow(_count, "lang string, gram string, n long")
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return LanguageModel([(r.lang, r.gram, r.n) for r in grams.toLocalIterator()])


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def _spans(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    """Runs of equally labelled words, from the first's start to the last's end (code points)."""
    at = [(m.start(), m.end()) for m in _RUN.finditer(text) if any(map(str.isalpha, m[0]))]
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return [{"start": at[a][0], "end": at[b - 1][1], "lang": langs[labels[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]


def label_languages(documents: DataFrame, model: LanguageModel, *, penalty: float = 8.0, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (the share of the text's letters that carry that
    label) and spans of every row, with the columns of ``extra`` carried along."""
    source = text_col if text_col in extra else "sw_text"
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def label(part: list[str | None], model: LanguageModel):
        index: dict[str, int] = {}
        docs = [[index.setdefault(w, len(index)) for w in letter_words(t)] for t in part]
        lengths = [len(d) for d in docs]
        ids = np.fromiter(chain.from_iterable(docs), np.int64, sum(lengths))
        labels = viterbi(model.word_scores(list(index))[ids], lengths, penalty)
        letters = np.fromiter(map(len, index), np.int64, len(index))[ids]
        rated = np.fromiter((script_of(w[0]) in model.candidates for w in index), bool, len(index))[ids]
        lo = 0
        for text, n in zip(part, lengths, strict=True):
            if not n:
                yield "und", 0.0, []
                continue
            own = labels[lo : lo + n]
            size, known = letters[lo : lo + n], rated[lo : lo + n]
            weight = np.bincount(own, size * known, len(model.langs))
            lo += n
            top = int(weight.argmax())
            yield model.langs[top], float(weight[top] / size.sum()), _spans(text, own, model.langs)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch[source].to_pylist()
            if not model.langs:
                out = [("und", 0.0, []) for _ in texts]
            else:
                out, part, size = [], [], 0
                for t in texts:  # parts of a few million characters are walked together
                    part.append(t)
                    size += len(t or "")
                    if size > 8_000_000:
                        out += label(part, model)
                        part, size = [], 0
                out += label(part, model)
            cols = [batch[c] for c in batch.schema.names if c != "sw_text"]
            cols += [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], _SPAN)]
            yield pa.RecordBatch.from_arrays(cols, names=[*(c for c in batch.schema.names if c != "sw_text"), "lang_pred", "score", "spans"])

    rows = documents.select(F.col(id_col).alias("doc_id"), *extra, *([] if text_col in extra else [F.col(text_col).cast("string").alias("sw_text")]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "sw_text")
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    model = fit_languages(documents.where(~held_out(F.col("doc_id"))))
    found = label_languages(documents, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
