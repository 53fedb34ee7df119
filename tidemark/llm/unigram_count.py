"""Token counts under a unigram vocabulary, without building the tokens.

Aho-Corasick enumerates the vocabulary pieces that end at each character; dynamic programming carries the best score
and the number of tokens on the path that has it. Ties follow the tokenizer: it extends paths from the left and
replaces one only by a strictly better score, so of equal paths to a place the one with the longest last piece
stays. A character without a piece of its own costs the lowest score less 10; it counts as its UTF-8 bytes where the
vocabulary has byte pieces, else a run of such characters counts as one token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.token_ids import _Index

# The mark that stands for a space, and what an unknown character costs below the lowest score.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_CHARS = 64


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces that match text, with scores, and whether there are byte pieces, from a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in plain]
    return pieces, any(model.is_byte(i) for i in ids)


class UnigramCounter:
    """Counts and scores of texts. ``max_units`` bounds remembered units, not what is counted."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, max_units: int = 400_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback
        self.max_units = max_units
        # No piece reaches over the start of a run of spaces, and each run starts with a known piece: every path
        # passes there, and units from one run to the next can be solved on their own.
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.by_unit = not any(inner.search(p) for p, _ in pieces) and any(p == SPACE for p, _ in pieces)
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.counts = np.zeros(0, np.int64)
        self.scores = np.zeros(0, np.float64)

    def solve(self, unit: str) -> tuple[int, float]:
        """Tokens and score of the best path over a unit."""
        n = len(unit)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(unit):
            found[end].append(piece)
        for end in range(n):
            top, size, single = None, 0, False
            for length, score in found[end]:
                total = best[end + 1 - length] + score
                single |= length == 1
                if top is None or total > top or (total == top and length > size):
                    top, size = total, length
            if not single and (top is None or best[end] + self.unknown > top):
                best[end + 1], unknown[end + 1] = best[end] + self.unknown, True
                step = len(unit[end].encode("utf-8", "surrogatepass")) if self.bytes else int(not unknown[end])
                count[end + 1] = count[end] + step
            else:
                best[end + 1], count[end + 1] = top, count[end + 1 - size] + 1
        return count[n], best[n]

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if new:
            solved = [self.solve(SPACE + w) for w in new]
            self.counts = np.concatenate([self.counts, np.array([c for c, _ in solved], np.int64)])
            self.scores = np.concatenate([self.scores, np.array([s for _, s in solved], np.float64)])

    def count(self, texts: list[str]) -> list[tuple[int, float]]:
        """Tokens and score of each text; an empty one has none."""
        if not self.by_unit:
            return [self.solve(SPACE + t.replace(" ", SPACE)) if t else (0, 0.0) for t in texts]
        if len(self.index) > self.max_units:
            self._forget()
        places, extra = [], []
        for text in texts:
            tokens, score = 0, 0.0
            # Between single spaces, words are units; a run of spaces goes with the word after it.
            words = text.replace(SPACE, " ").split(" ") if text else []
            if "" in words or len(text) > CACHED_CHARS * len(words):
                units = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE)) if text else []
                words = []
                for unit in units:
                    if unit.startswith(SPACE) and not unit.startswith(SPACE * 2) and len(unit) <= CACHED_CHARS:
                        words.append(unit[1:])
                    else:
                        c, s = self.solve(unit)
                        tokens, score = tokens + c, score + s
            places.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
            extra.append((tokens, score))
        self._learn()
        return [
            (int(self.counts[p].sum()) + c, float(self.scores[p].sum()) + s) for p, (c, s) in zip(places, extra)
        ]


def counter(path: str) -> UnigramCounter:
    """The worker's counter of a file."""
    return common.kept(("unigram counts", path), lambda: UnigramCounter(*vocabulary(path)))


def token_counts(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score`` of every row under the vocabulary of the file ``path``.

    A space is the mark of the vocabulary, and one stands before each text. Null and empty texts have no tokens and
    score 0; null ids stay null; repeated rows are counted each; other columns are not read.
    """
    common.ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = counter(path).count(common.texts_of(batch.column(1)))
            yield pa.record_batch([
                batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64()),
            ], ["doc_id", "n_tokens", "score"])

    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, score double")
