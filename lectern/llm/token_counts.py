"""Numbers of unigram-model tokens, without building the tokens.

Viterbi over a unigram vocabulary: an Aho-Corasick automaton lists every piece of the
vocabulary that ends at a position, and dynamic programming keeps, for each position,
the best score and the number of pieces on the best path, nothing else.

Tie rules are those of the tokenizers library's unigram model: paths that end at one
position are tried from the earliest start on, and only a strictly better score
replaces a path. A character that is no piece of its own costs the lowest score less
ten and counts as its UTF-8 bytes (byte fallback). Words are cut before each space,
which belongs to the word after it; the text gets a space in front unless it has one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_name, tokenizer_file

PIECE_MODEL = "piece_bpe_32k.model"
# How the vocabulary writes a space.
SPACE = "▁"
# Fixed by the tokenizer: what an unknown character costs beside the lowest score.
UNKNOWN_PENALTY = 10.0
# Words in a generation of a task's cache. A full generation becomes the old one, from
# which words that come again are taken over; the one before it goes.
CACHE_WORDS = 150_000
_COUNTERS: dict[str, UnigramCounter] = {}


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces with scores from a sentencepiece file, control and byte pieces left out.

    The public file ranks its pieces; a rank's log probability follows Zipf's law.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [
        i
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    whole = sum(1 / (rank + 1) for rank in range(len(usual)))
    usual.sort(key=model.get_score, reverse=True)
    return [(model.id_to_piece(i), -math.log((k + 1) * whole)) for k, i in enumerate(usual)]


class UnigramCounter:
    """Counts the pieces of the best segmentation of a text."""

    def __init__(self, vocabulary: list[tuple[str, float]], cache_words: int = CACHE_WORDS):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self._alone = {piece for piece, _ in vocabulary if len(piece) == 1}
        self._cache_words = cache_words
        self._known: dict[str, int] = {}
        self._old: dict[str, int] = {}

    def best(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of the best path; the earlier path wins a tie."""
        score = [0.0] + [-math.inf] * len(word)
        count = [0] * len(score)
        strange = [i for i, c in enumerate(word) if c not in self._alone][::-1]

        def step(at: int) -> None:
            offered = self._unknown + score[at]
            if offered > score[at + 1]:
                score[at + 1] = offered
                count[at + 1] = count[at] + len(word[at].encode())

        # Matches come by end, the longest first: at each end from the earliest start.
        for last, (length, gain) in self._automaton.iter(word):
            while strange and strange[-1] < last:
                step(strange.pop())
            end = last + 1
            offered = gain + score[end - length]
            if offered > score[end]:
                score[end] = offered
                count[end] = count[end - length] + 1
        for at in reversed(strange):
            step(at)
        return score[-1], count[-1]

    def count(self, text: str) -> int:
        """Number of pieces of a whole text; an empty text has none."""
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        words = (text[1:] if text[0] == " " else text).split(" ")
        found = list(map(self._known.get, words))
        if None in found:
            new = {w for w in words if w not in self._known}
            if len(self._known) + len(new) > self._cache_words:
                self._old, self._known = self._known, {}
                new = set(words)
            for w in new:
                before = self._old.get(w)
                self._known[w] = self.best(SPACE + w)[1] if before is None else before
            found = list(map(self._known.get, words))
        return sum(found)


def counter(path: str) -> UnigramCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(unigram_vocabulary(path))
    return _COUNTERS[path]


def count_tokens(
    docs: DataFrame, text_col: str = "text", output: str = "n_tokens", model: str | None = None
) -> DataFrame:
    """Add the number of tokens of every whole text; rows stay where they are.

    A null or empty text has none. A column that already has the output's name is
    replaced.
    """
    kept = docs.drop(output) if output != text_col else docs
    others = [c for c in kept.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model or tokenizer_file(PIECE_MODEL)).count
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = pa.array([count(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], counts], names=[*others, output]
            )

    staged = kept.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").alias(free_name(kept, "_text")))
    return staged.mapInArrow(run, f"{schema}, `{output}` long")
