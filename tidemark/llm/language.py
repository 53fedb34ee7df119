"""Language of texts and of spans in them.

The script of a word narrows its candidates to the languages that use the script in the training texts. Each word has
a score per candidate from its letters and letter pairs and triples; Viterbi with a penalty per switch then labels
the words, and words of one label in a row make a span. A word is known if a language uses its script and its letters
are about as likely as those of the training texts; others say nothing of the language of their text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.token_ids import _Index

UNDETERMINED = "und"
FEATURES = 1 << 16
SWITCH = 12.0
MOST_LANGUAGES = 256
SCRIPT_SHARE = 0.005
FAR_BELOW = 6.0  # nats a letter under the mean of a language's training texts
WORDS_AT_ONCE = 20_000  # words whose letters are laid out in memory together
# First code points of script ranges, and the scripts written without spaces.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, "other"),
    (0x1780, "khmer"), (0x1800, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"),
    (0x2E00, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE20, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
)
UNSPACED = "฀-໿က-႟ក-៿⺀-ヿ㐀-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
# Letters up to Latin Extended-A, and words of any script: one letter where words are not spaced.
LATIN = re.compile("[a-zA-ZªµºÀ-ÖØ-öø-ſ]+")
BEYOND = re.compile("[^\x00-ſ]")
WORD = regex.compile(f"(?V1)[[{UNSPACED}]&&\\p{{L}}]|[\\p{{L}}--[{UNSPACED}]][[\\p{{L}}\\p{{M}}]--[{UNSPACED}]]*")
NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS])
_SCRIPT_AT = np.array([NAMES.index(name) for _, name in SCRIPTS])
_LONGEST = 48  # words are remembered up to this length; longer ones are scored each time


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case."""
    low = text.lower()
    return (WORD if BEYOND.search(low) else LATIN).findall(low)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three hashed features per letter, each word's first letter, and each word's script."""
    code = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    at = np.flatnonzero(code != 10)
    one, two, three = code[at], code[at + 1], code[at - 1]
    mix = np.uint64(0x9E3779B97F4A7C15)
    pair = one << np.uint64(21) | two | np.uint64(1 << 62)
    triple = one | two << np.uint64(21) | three << np.uint64(42) | np.uint64(1 << 63)
    keys = np.stack([one, pair, triple], 1)
    hashed = (keys ^ (keys >> np.uint64(29))) * mix
    hashed = ((hashed ^ (hashed >> np.uint64(32))) * mix >> np.uint64(48)).astype(np.int64)
    first = np.searchsorted(at, np.concatenate([[0], np.flatnonzero(code == 10)[1:-1]]) + 1)
    script = _SCRIPT_AT[np.searchsorted(_STARTS, code[at[first]].astype(np.int64), side="right") - 1]
    return hashed, first, script


@dataclass
class LanguageModel:
    """Languages, log-probability of each feature per language, and which language uses which script."""

    languages: list[str]
    logp: np.ndarray  # features x languages
    uses: np.ndarray  # scripts x languages
    least: np.ndarray  # per language: least log-probability a letter of a known word
    switch: float = SWITCH
    number: str = field(default_factory=lambda: uuid.uuid4().hex)
    index: _Index = field(default_factory=_Index)
    known: np.ndarray | None = None
    max_words: int = 300_000

    def __getstate__(self):
        names = ("languages", "logp", "uses", "least", "switch", "number")
        return {name: getattr(self, name) for name in names}

    def __setstate__(self, state):
        self.__dict__.update(state, index=_Index(), known=None, max_words=300_000)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Words x languages, and what is known of each word: 1 all, 0 its script, -1 nothing.

        A language that lacks the word's script is far below; a script nobody has says nothing.
        """
        if not words:
            return np.zeros((0, len(self.languages) + 1), np.float32)
        if len(words) > WORDS_AT_ONCE:
            parts = range(0, len(words), WORDS_AT_ONCE)
            return np.concatenate([self.score_words(words[at : at + WORDS_AT_ONCE]) for at in parts])
        hashed, first, script = _letters(words)
        scores = np.add.reduceat(self.logp[hashed].sum(1), first, axis=0)
        uses = self.uses[script]
        sizes = np.diff(np.append(first, len(hashed)))[:, None]
        known = np.where((uses & (scores >= sizes * self.least)).any(1), 1, np.where(uses.any(1), 0, -1))
        scores = np.where(uses, scores, scores.max(1, keepdims=True) - 4 * self.switch)
        scores[~uses.any(1)] = 0
        return np.column_stack([scores - scores.max(1, keepdims=True), known]).astype(np.float32)

    def _scores(self, words: list[list[str]]) -> list[np.ndarray]:
        if len(self.index) > self.max_words or self.known is None:
            self.index, self.known = _Index(), np.zeros((0, len(self.languages) + 1), np.float32)
        longest = [len(max(some, key=len, default="")) for some in words]
        long = [
            [i for i, w in enumerate(some) if len(w) > _LONGEST] if n > _LONGEST else []
            for some, n in zip(words, longest)
        ]
        places = []
        for some, over in zip(words, long):
            short = some if not over else [w[:1] if len(w) > _LONGEST else w for w in some]
            places.append(np.fromiter(map(self.index.__getitem__, short), np.int64, len(short)))
        new, self.index.new = self.index.new, []
        self.known = np.concatenate([self.known, self.score_words(new)])
        out = []
        for some, place, over in zip(words, places, long):
            scores = self.known[place]
            if over:
                scores[over] = self.score_words([some[i] for i in over])
            out.append(scores)
        return out

    def label(self, scores: np.ndarray) -> np.ndarray | int:
        """The best language of every word; one number where a single language is best throughout."""
        best = int(scores.sum(0, dtype=np.float64).argmax())
        if scores.shape[1] == 1:
            return best
        # What any run of words can gain by other languages. A run costs two switches, one at an end of the text.
        others = scores.copy()
        others[:, best] = -np.inf
        gain = np.cumsum(others.max(1) - scores[:, best], dtype=np.float64)
        before = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
        at_start, at_end = gain.max(), gain[-1] - before.min()
        if max(at_start, at_end) <= self.switch and (gain - before).max() <= 2 * self.switch:
            return best
        return _viterbi(scores, self.switch)

    def identify(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans (first and last character + 1, language) of each text.

        Of a text without known words the language is the first that could be, and the score 0.
        """
        return [found[:3] for found in self.examine(texts)]

    def examine(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
        """The same, and the share of the letters that are in known words of any language."""
        nothing = (UNDETERMINED, 0.0, [], 0.0)
        if not self.languages:
            return [nothing] * len(texts)
        words = [words_of(t) if t else [] for t in texts]
        out = []
        for text, some, scored in zip(texts, words, self._scores(words)):
            if not some:
                out.append(nothing)
                continue
            scores, known = scored[:, :-1], scored[:, -1]
            labels = self.label(scores)
            letters = np.fromiter(map(len, some), np.int64, len(some))
            sure, foreign = np.where(known > 0, letters, 0), known < 0
            every, evidence = int(letters.sum()), float(sure.sum() / letters.sum())
            if isinstance(labels, int) and not foreign.any():
                name = self.languages[labels]
                out.append((name, evidence, [(len(text) - len(text.lstrip()), len(text.rstrip()), name)], evidence))
                continue
            labels = np.broadcast_to(labels, len(some))
            sizes = np.bincount(labels, sure, len(self.languages))
            best = int(sizes.argmax()) if evidence else int(np.bincount(labels, letters).argmax())
            spans = self._spans(text, np.where(foreign, len(self.languages), labels))
            out.append((self.languages[best], float(sizes[best] / every), spans, evidence))
        return out

    def _spans(self, text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
        # Words are found in the lower-cased text, whose length differs where a capital has two small characters.
        low = text.lower()
        places = [m.span() for m in (WORD if BEYOND.search(low) else LATIN).finditer(low)]
        if len(low) != len(text):
            ends = np.concatenate([[0], np.cumsum([len(c.lower()) for c in text])])
            places = [tuple(np.searchsorted(ends, p, side="left").tolist()) for p in places]
        cuts = np.flatnonzero(np.diff(labels)) + 1
        runs = zip([0, *cuts.tolist()], [*cuts.tolist(), len(labels)])
        names = [*self.languages, UNDETERMINED]
        return [(places[a][0], places[b - 1][1], names[int(labels[a])]) for a, b in runs]


def _viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word."""
    came = []
    rows = scores.astype(np.float64).tolist()
    total = rows[0]
    for row in rows[1:]:
        top = max(total)
        least, at = top - switch, total.index(top)
        came.append([at if x < least else -1 for x in total])
        total = [(least if x < least else x) + y for x, y in zip(total, row)]
    out = np.empty(len(rows), np.int64)
    at = total.index(max(total))
    out[-1] = at
    for t in range(len(came) - 1, -1, -1):
        if came[t][at] >= 0:
            at = came[t][at]
        out[t] = at
    return out


def train(
    documents: DataFrame, lang_col: str = "lang", text_col: str = "text", switch: float = SWITCH,
) -> LanguageModel:
    """Count the features of all rows that have a language and a text, per language.

    The counts of a task are summed before the shuffle. The model has at most ``MOST_LANGUAGES`` times ``FEATURES``
    numbers; more languages are an error. No rows give a model without languages.
    """
    common.ship(documents.sparkSession)
    rows = documents.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        memory: dict[str, dict[str, int]] = {}

        def flush() -> None:
            for lang, seen in memory.items():
                if not seen:
                    continue
                features, scripts = sums.setdefault(lang, (np.zeros(FEATURES, np.int64), np.zeros(len(NAMES), np.int64)))
                words, counts = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
                for at in range(0, len(words), WORDS_AT_ONCE):
                    times = counts[at : at + WORDS_AT_ONCE]
                    hashed, first, script = _letters(words[at : at + WORDS_AT_ONCE])
                    each = np.repeat(times, np.diff(np.append(first, len(hashed))))
                    features += np.bincount(hashed.ravel(), np.repeat(each, 3), FEATURES).astype(np.int64)
                    scripts += np.bincount(script, times, len(NAMES)).astype(np.int64)
                seen.clear()

        for batch in common.slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = memory.setdefault(lang, {})
                for word in words_of(text):
                    seen[word] = seen.get(word, 0) + 1
            if sum(map(len, memory.values())) > 200_000:
                flush()
        flush()
        for lang, (features, scripts) in sums.items():
            both = np.concatenate([features, scripts])
            some = np.flatnonzero(both)
            yield pa.record_batch([
                pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(both[some]),
            ], ["lang", "feature", "n"])

    counted = rows.mapInArrow(count, "lang string, feature int, n long")
    sums = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    sums = common.written(sums, common.work_dir(documents.sparkSession, "language-counts"))
    languages = [r.lang for r in sums.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return _model(sorted(languages), sums.toPandas(), switch)


def _model(languages: list[str], sums, switch: float) -> LanguageModel:
    counts = np.zeros((FEATURES + len(NAMES), len(languages)))
    if languages:
        where = {lang: i for i, lang in enumerate(languages)}
        counts[sums["feature"].to_numpy(), sums["lang"].map(where).to_numpy()] = sums["n"].to_numpy()
    features, scripts = counts[:FEATURES], counts[FEATURES:]
    logp = np.log((features + 0.5) / (features.sum(0) + 0.5 * FEATURES))
    uses = scripts > SCRIPT_SHARE * scripts.sum(0)
    # A letter has three features.
    mean = 3 * (features * logp).sum(0) / np.maximum(features.sum(0), 1)
    return LanguageModel(languages, logp.astype(np.float32), uses, mean - FAR_BELOW, switch)


def identify(
    documents: DataFrame, model: LanguageModel, text_col: str = "text", evidence_col: str | None = None
) -> DataFrame:
    """Every row with ``lang_pred``, ``score`` and ``spans`` (start, end, lang) in place of columns so named.

    ``lang_pred`` is the language with the most letters in known words, ``score`` their share of all letters. A text
    that is null or has no letter, and any text if nothing was learned, is ``und`` with score 0 and no spans. A text
    with letters always has a learned language: without known words, that of the most letters, with score 0. Of equal
    shares the language first in order wins. Runs of words in a script that no language uses are spans of ``und``.
    ``evidence_col`` adds the share of the letters that are in known words of any language; a caller rejects by it.
    """
    spark = documents.sparkSession
    common.ship(spark)
    results = ("lang_pred", "score", "spans", *([evidence_col] if evidence_col else []))
    keep = [c for c in documents.columns if c not in results]
    state = spark.sparkContext.broadcast(model)
    place = keep.index(text_col)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = common.kept(("language", state.value.number), lambda: state.value)
        for batch in common.slices(batches, 256):
            found = model.examine(batch.column(place).to_pylist())
            columns = [
                pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in f[2]] for f in found], spans),
                pa.array([f[3] for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns[: len(results)]], [*keep, *results])

    kept = documents.select(*keep)
    schema = kept.limit(0).selectExpr(
        "*", "'' AS lang_pred", "0D AS score", "array(named_struct('start', 0, 'end', 0, 'lang', '')) AS spans",
        *([f"0D AS `{evidence_col}`"] if evidence_col else []),
    ).schema
    return kept.mapInArrow(run, schema)


def held_out(key: str = "doc_id", fold: int = 0, folds: int = 5) -> Column:
    """Whether the crc32 of a key's text falls in the held-out fold."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold
